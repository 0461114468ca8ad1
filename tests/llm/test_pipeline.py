"""The pipeline's stages, each on what the one before kept."""

import collections

import corpus_pipeline as P


def test_stages(spark, tmp_path):
    words = "the quick brown fox jumps over a lazy dog while nobody looks at it in this calm and sunny garden".split()
    make = lambda k, n: " ".join(f"{words[(k * 7 + i * (k % 5 + 1)) % len(words)]}{k if i % 3 else ''}" for i in range(n)) + "."
    passage = " ".join(f"shared{i}" for i in range(60))
    texts = [make(k, 80) for k in range(20)]
    texts += [texts[0].replace(" ", "  "), texts[1] + " tail", passage + " " + make(30, 60), make(31, 60) + " " + passage]
    junk = ["SALE!! SALE!! NOW!! " * 10 + str(k) for k in range(20)]
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate([*texts, *junk])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < len(texts))) for i in range(len(rows))], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    at, seen = docs, {}
    for name, stage in P.STAGES:
        at = stage(spark, at, str(tmp_path))
        at.write.parquet(f"{tmp_path}/out-{name}")
        at = spark.read.parquet(f"{tmp_path}/out-{name}")
        seen[name] = at
    kept = lambda name: sorted(r["doc_id"] for r in seen[name].select("doc_id").collect())
    assert kept("quality") == list(range(24))
    assert kept("exact_dedup") == [*range(1, 24)]  # 20 is 0 with more white space, so more code points
    assert 21 not in kept("near_dedup") and {22, 23} <= set(kept("near_dedup"))
    left = {r["doc_id"]: r for r in seen["substring_dedup"].collect()}
    assert "shared5" in left[22]["text"] and "shared5" not in left[23]["text"] and left[23]["n_chars"] == len(left[23]["text"])
    assert left[5]["text"] == texts[5] and seen["substring_dedup"].columns == P.COLUMNS
    tokens = collections.Counter()
    for r in seen["packing"].collect():
        tokens[r["doc_id"]] += r["length"]
        assert r["doc_tokens"] >= r["length"]
    assert sorted(tokens) == sorted(left)
    assert P.run(spark, str(tmp_path)).count() == seen["packing"].count()


def test_stages_on_awkward_rows(spark, tmp_path):
    long = " ".join(f"word{i % 1013}" for i in range(25_000))
    rows = [
        (None, None, None, None, None, 1, "a", 7), (None, "a text of some words", "en", None, 20, None, "b", 7), (1, "", "en", "s", 0, 2, None, 7), (2, "twice told tale of words", "en", "s", 24, 3, "c", 7),
        (2, "twice told tale of words", "en", "s", 24, 3, "c", 7), (2, "another text", "en", "s", None, 4, "d", 7), (3, long, "en", "t", 1, 5, "e", 7), (4, long + " end", "en", "t", 1, 6, "f", 7),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id long, content string, row long")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(P.STAGES)
    count = lambda name, df: collections.Counter((r["doc_id"], (r["text"] or "")[:20]) for r in stages[name](spark, df, str(tmp_path)).collect())
    every = collections.Counter((r[0], (r[1] or "")[:20]) for r in rows)
    assert count("quality", docs) in (every, collections.Counter())  # without labels one score decides
    once = collections.Counter(set(every)) - collections.Counter([(None, "")])  # the empty texts are one, an id before none
    assert count("exact_dedup", docs) == once
    kept = collections.Counter(set(every)) - collections.Counter([(4, long[:20])])
    assert count("near_dedup", docs) == kept
    left = stages["substring_dedup"](spark, docs, str(tmp_path)).collect()
    assert len(left) == len(rows) and all(list(r.asDict()) == P.COLUMNS for r in left)
    assert [r["text"] for r in left if r["doc_id"] == 3 and r["text"]] and [len(r["text"]) < 200 for r in left if r["doc_id"] == 4] == [True]
    pieces = stages["packing"](spark, docs, str(tmp_path)).collect()
    assert sum(r["start"] == 0 for r in pieces) == len(rows)
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
