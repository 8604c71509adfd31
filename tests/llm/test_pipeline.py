"""The pipeline's stages on a small corpus: decisions take effect, clean documents stay."""

import random

import corpus_pipeline
from tests.llm.test_operators import DOCS, ENGLISH, GERMAN, shingles, words


def test_pipeline(spark, tmp_path):
    rng = random.Random(1)
    bench = [(k, words(rng, 25)) for k in range(3)]
    rows = [(k, words(rng, 150, GERMAN if k % 4 == 0 else ENGLISH) + f" u{k}", "de" if k % 4 == 0 else "en", f"src{k % 3}") for k in range(200)]
    clean = {r[0] for r in rows}
    rows += [(300, rows[10][1].upper(), "en", "src1"), (301, rows[11][1].replace("the", "tha", 1), "en", "src1")]
    rows += [(302, words(rng, 60, ENGLISH) + " " + bench[1][1], "en", "src0"), (303, "12 34", None, None), (304, None, None, "src2")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        if n < 4:
            assert out.columns == at.columns, name
        out.write.parquet(f"{tmp_path}/{n}")
        at = spark.read.parquet(f"{tmp_path}/{n}")
        seen.append({r["doc_id"] for r in at.select("doc_id").collect()})
    everything = {r[0] for r in rows}
    assert everything - seen[0] == {303, 304}
    assert seen[0] - seen[1] == {10}
    assert seen[1] - seen[2] == {301}
    assert seen[2] - seen[3] == {302}
    assert clean - {10} <= seen[3]
    assert at.columns[:2] == ["doc_id", "source"] and {"target", "taken"} <= set(at.columns)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == seen[4]


def test_stages():
    assert len(corpus_pipeline.STAGES) == 5 and [n for n, _ in corpus_pipeline.STAGES][0] == "language ID"


def test_near_stage_links_from_80_percent(spark):
    rng = random.Random(7)
    rows = []
    for k in range(0, 20, 2):
        t = words(rng, 150).split()
        near, far = list(t), list(t)
        for at in (30, 70, 110):
            near[at] = f"n{k}"
        for at in (20, 50, 80, 110):
            far[at] = f"f{k}"
        a, b, c = (shingles(" ".join(x)) for x in (t, near, far))
        assert 0.80 <= len(a & b) / len(a | b) < 0.83 and len(a & c) / len(a | c) < 0.80 and len(b & c) / len(b | c) < 0.80
        rows += [(k, " ".join(t)), (k + 1, " ".join(near)), (100 + k, " ".join(far))]
    out = corpus_pipeline.near(spark, spark.createDataFrame(rows, DOCS), "")
    assert {r["doc_id"] for r in out.collect()} == {i for i, _ in rows if i % 2 == 0}


WIDE = f"{DOCS}, lang string, source string, n_chars long, score double, rejected string, group_size int, keep_id string, finger int, mark int, p0 int, m_key int, item string"


def stage_inputs(spark, tmp_path):
    """A stage's input with repeated rows, nulls, empty and very long texts, and columns named like the operators' own."""
    rng = random.Random(3)
    rows = [(k, words(rng, 80, GERMAN if k % 2 else ENGLISH), "de" if k % 2 else "en", f"s{k % 3}") for k in range(60)]
    rows += [rows[8], rows[8], (8, rows[8][1].title(), "en", "s1"), (None, rows[9][1], None, None), (None, rows[9][1], None, None), (None, words(rng, 70, ENGLISH), "en", "s0")]
    rows += [(200, None, None, None), (201, "", "en", "s0"), (202, " ", "en", "s0"), (None, None, None, None), (203, words(rng, 60_000, ENGLISH), "en", "s2"), (204, "½ 12", "en", "s0")]
    bench = [(0, words(rng, 20)), (1, rows[12][1])]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return spark.createDataFrame([(*r, 1, 777.0, "own", 5, "k", 6, 7, 8, 9, "i") for r in rows], WIDE), rows


def test_stages_keep_every_column_of_their_input(spark, tmp_path):
    df, rows = stage_inputs(spark, tmp_path)
    whole = {r for r in map(tuple, df.collect())}
    out = {name: stage(spark, df, str(tmp_path)) for name, stage in corpus_pipeline.STAGES[:4]}
    got = {name: list(map(tuple, x.collect())) for name, x in out.items()}
    assert all(x.columns == df.columns and x.schema == df.schema for x in out.values())
    assert all(set(x) <= whole for x in got.values())
    # language: all but those without a letter
    assert len(got["language ID"]) == len(rows) - 5
    # exact: a row of each text
    assert sorted((r[1] or "").lower() for r in got["exact dedup"]) == sorted({(t or "").lower() for _, t, _, _ in rows})
    # near: a row of each set of shingles (no others are near here), and all rows without words
    sets = [shingles(t) for _, t, _, _ in rows]
    assert len(got["near dedup"]) == len({x for x in sets if x}) + sum(not x for x in sets)
    assert sum(r[0] == 8 for r in got["near dedup"]) == 1 and {r[0] for r in got["near dedup"] if r[1] and r[1].lower() == rows[9][1]} == {9}
    # decontamination: a document is an item of the benchmark
    assert len(got["decontamination"]) == len(rows) - 1 and 12 not in {r[0] for r in got["decontamination"]}
    mixed = corpus_pipeline.mixture(spark, df, str(tmp_path)).collect()
    assert all(r["taken"] <= 2 * r["size"] for r in mixed) and 203 in {r["doc_id"] for r in mixed}


def test_stages_of_an_empty_table(spark, tmp_path):
    df, _ = stage_inputs(spark, tmp_path)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0, name


def test_pipeline_against_brute_force(spark, tmp_path):
    """Dedup and decontamination by plain Python on what the language stage keeps; the mix takes of what is left."""
    rng = random.Random(9)
    rows = [(k, words(rng, rng.choice([30, 120]), ENGLISH) + f" x{k}", "en", f"s{k % 2}") for k in range(120)]
    for k in range(60):
        t = rng.choice(rows)[1].split()
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            t[rng.randrange(len(t))] = f"n{k}"
        rows.append((500 + k, " ".join(t) if k % 4 else " ".join(t).upper(), "en", "s0"))
    bench = [(k, words(rng, 16)) for k in range(4)]
    rows += [(800 + k, f"{words(rng, 40, ENGLISH)} {bench[k % 4][1]}", "en", "s1") for k in range(8)]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], f"{DOCS}, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.language(spark, docs, str(tmp_path)).collect()}
    assert len(left) > len(rows) - 10
    last = {t.lower(): i for i, t in sorted(left.items())}
    left = {i: left[i] for i in last.values()}
    sets, up = {i: shingles(t) for i, t in left.items()}, {i: i for i in left}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in left:
        for b in left:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    left = {i: t for i, t in left.items() if root(i) == i}
    for k, item in bench:
        v = item.split()
        for i, t in list(left.items()):
            h = t.split()
            if any(sum(x == y for x, y in zip(h[p : p + 13], v[q : q + 13], strict=False)) >= 11 for p in range(len(h) - 12) for q in range(len(v) - 12)):
                del left[i]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} <= set(left) and len(left) < 150
    sizes = {i: len(t.split()) for i, t in left.items()}
    assert all(r["size"] == sizes[r["doc_id"]] and r["taken"] <= 2 * r["size"] for r in got)
    assert abs(sum(r["taken"] for r in got) - 1.5 * sum(sizes.values())) < 3 * 256
