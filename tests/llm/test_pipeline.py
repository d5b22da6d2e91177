"""The pipeline, stage by stage, against plain versions on the smallest tables."""
import corpus_pipeline
from kinsift.llm import quality_rules
from tests.llm.test_ngram_join import brute, shingles, words
from tests.llm.test_operators import keyed, plain_dedup, plain_targets

SF = "/root/testdata/sf0.001"


def test_every_stage_against_a_plain_version(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(900_001, None, "en", None, 0), (None, "of the " * 40, None, "src0", 280), (900_002, "", "en", "src1", 0)], docs.schema)
    docs, columns = docs.unionByName(odd).unionByName(docs.limit(3)), docs.columns
    taken = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(path := str(tmp_path / name))
        docs = spark.read.parquet(path)
        taken[name] = ([tuple(r) for r in before.select("doc_id", "text").collect()], docs.collect())
        if name != "mixing":
            assert docs.columns == columns

    before, after = taken["quality_rules"]
    all_rows = spark.createDataFrame(before, "doc_id long, text string")
    kept = [(r.doc_id,) for r in quality_rules.score(all_rows).where("kept").collect()]
    assert sorted(((r.doc_id,) for r in after), key=str) == sorted(kept, key=str) and len(after) < len(before)

    before, after = taken["ngram_jaccard_join"]
    groups = {g for _, n, g in brute(before) if n}
    assert sorted((r.doc_id for r in after), key=str) == sorted(groups, key=str) and len(after) < len(before)
    assert {(r.doc_id, r.text) for r in after} <= set(before)

    before, after = taken["substring_dedup"]
    plain = {k: v[0] for k, v in plain_dedup(keyed(spark.createDataFrame(before, "doc_id long, text string"))).items()}
    assert sorted((str((r.doc_id, r.text)) for r in after)) == sorted(str((d, t)) for (d, _), t in plain.items() if words(t))
    assert all(r.n_chars == len(r.text) for r in after)
    assert any(t != plain[d, t] for d, t in before)

    before, after = taken["benchmark_decontamination"]
    items = [shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [d for d, t in before if not any(s and 100 * len(s & shingles(t)) >= 75 * len(s) for s in items)]
    assert sorted((r.doc_id for r in after), key=str) == sorted(clean, key=str) and len(after) < len(before)

    before, after = taken["mixing"]
    assert sorted((str((r.doc_id, r.size)) for r in after)) == sorted(str((d, len(words(t)))) for d, t in before)
    sizes = {}
    for r in after:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        assert r.taken == r.copies * r.size <= 2 * r.size
    targets = plain_targets(sizes)
    assert all(abs(r.target - targets[r.source]) < 1e-6 for r in after)


def test_run_chains_the_stages_and_an_empty_table_stays_empty(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "source", "size", "source_size", "target", "copies", "taken"] and out.count() > 100
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_stage_works_out_a_text_again_for_its_filter(spark):
    """Memory and time: Spark moves filters below the columns they read and works these out once more."""
    docs = spark.createDataFrame([(i, f"{i} " + "the cat sat on the mat and saw a dog that ran far away from the old house by the big lake in the cold of the night. " * 2,
                                   "en", "src0", 0) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long")
    cut = corpus_pipeline.substrings(spark, docs, SF)
    assert _optimized(cut).count("ArrowEvalPython") == 1
    assert cut.count() == 30 and cut.where("length(text) < 100").count() >= 20
    kept = quality_rules.keep_good(docs)
    assert _optimized(kept).count("regexp_extract_all") == 1
    assert kept.columns == docs.columns


def test_kept_rows_are_those_that_the_scores_keep(spark):
    texts = [None, "", " \n", "word " * 30, "of the cat and the dog " * 12, "# $ % of a sign " * 20, "Of all that is in the house, a cat was by the door for an hour; "
             "it saw the dog and the old man as they came from the road.\nThen it ran.\nNobody knew where it had been until the morning after.\n", "x1 22 333 " * 30]
    docs = spark.createDataFrame([(i, t * k if t else t, 1, "q") for i, t in enumerate(texts) for k in (1, 2, 3)], "doc_id long, text string, f_words int, quality string")
    scored = quality_rules.score(docs.select("doc_id", "text"), ("doc_id",)).where("kept")
    assert sorted(r.doc_id for r in quality_rules.keep_good(docs).collect()) == sorted(r.doc_id for r in scored.collect())
    assert quality_rules.keep_good(docs).columns == docs.columns
