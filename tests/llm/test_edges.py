"""Empty tables, and tables whose other columns have the names that operators use inside, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quartzgrid.llm import decontamination, line_dedup, near_copies, neighbours, packing, quality_classifier, registry, secret_scan, sharding, simhash, substring_dedup, token_counts

HOSTILE = ("id version line lines gone __gone __id __version __of __removed __lines own_id own_version n_lines n_lost words h1 h2 first halves near node root key size c0 c1 c2 place arrival __arrival owner repository span row spans found "
           "fp component_id s1 s2 stays starts counts n start hashes block at salt postings declared label held_out score item item_id n_words fingerprint all window similarity asks vector dim slot group").split()
TEXTS = ["alpha beta gamma delta epsilon zeta eta theta iota", "alpha beta gamma delta epsilon zeta eta theta iota\nsecond line here", None, "", "secret=abcdef123456 and more words to read", "alpha beta gamma delta epsilon zeta eta theta iota"]
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows=None):
    given = [(k, t, "en", f"s{k % 2}", len(t or "")) for k, t in enumerate(TEXTS)] if rows is None else rows
    return spark.createDataFrame(given, DOCUMENTS)


def hostile(spark, case=True):
    """Each extra column says its name, so a value that was overwritten would show."""
    out = documents(spark)
    for name in HOSTILE + (["TEXT", "Doc_Id"] if case else []):
        out = out.toDF(*out.columns).select("*", F.lit(f"own {name}").alias(name)) if name not in ("TEXT", "Doc_Id") else out.select("*", F.lit(f"own {name}").alias(name))
    return out


def tables(spark, folder, rows=None):
    documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    empty = rows == []
    spark.createDataFrame([] if empty else [(k, [float(k == j) + 0.1 for j in range(8)], 0) for k in range(60)], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame([] if empty else [(1, TEXTS[0])], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([] if empty else [(k, k % 2, 0) for k in range(6)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(registry.CATALOG.queries))
def test_queries_over_empty_tables(spark, tmp_path, name):
    assert registry.CATALOG.queries[name](spark, tables(spark, tmp_path, [])).count() == 0


def test_pipeline_over_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, [])).count() == 0


def unchanged(before, after):
    """The rows that stay have all their other columns as they were."""
    assert after.columns == before.columns
    at = [k for k, c in enumerate(before.columns) if c not in ("text", "n_chars")]
    old = {str([r[k] for k in at]) for r in before.collect()}
    return [r for r in after.collect() if str([r[k] for k in at]) not in old] == []


def test_operators_that_keep_columns(spark):
    docs = hostile(spark)
    labels = spark.createDataFrame([(k, k % 2) for k in range(6)], "doc_id long, quality int")
    machine = quality_classifier.train(docs, labels)
    items = spark.createDataFrame([(1, TEXTS[0], "x", "y")], "item_id long, text string, item string, size string")
    assert unchanged(docs, quality_classifier.keep_good(docs, machine, 0.0))
    assert unchanged(docs, line_dedup.dedup_lines(docs, length_column="n_chars"))
    assert unchanged(docs, near_copies.keep_one_of_each(docs))
    assert unchanged(docs, decontamination.drop_leaks(docs, items))
    counted = line_dedup.dedup_lines(docs, counts=("n_lines", "lines"))
    assert counted.columns == [*docs.columns, "n_lines_", "lines_"]


def test_operators_that_read_two_columns(spark):
    docs, plain = hostile(spark), documents(spark)
    path = __import__("public_tokenizers").path
    for apply in (
        lambda d: packing.pack(d, path("word_bpe_49k.json")).drop("sequence_id", "offset"), lambda d: token_counts.count_tokens(d, path("byte_bpe_50k.json")), lambda d: simhash.classes(d), lambda d: substring_dedup.dedup_passages(d, 5),
        lambda d: decontamination.find_leaks(d, spark.createDataFrame([(1, TEXTS[0])], "item_id long, text string")), lambda d: quality_classifier.score(d, quality_classifier.Machine(0.1, *_weights())),
    ):
        assert sorted(map(str, apply(docs).collect())) == sorted(map(str, apply(plain).collect()))
    scanned = [sorted(str(r) for r in secret_scan.scan(d, F.lit("r"), F.lit("o")).collect()) for d in (hostile(spark, case=False), plain)]
    assert scanned[0] == scanned[1]
    vectors = spark.createDataFrame([(k, [1.0, float(k)], "x", "y") for k in range(9)], "vec_id long, embedding array<float>, id string, dim string")
    assert sorted(map(str, neighbours.nearest(vectors, F.col("vec_id") == 0).collect())) == sorted(map(str, neighbours.nearest(vectors.drop("id", "dim"), F.col("vec_id") == 0).collect()))


def _weights():
    import numpy as np

    return np.zeros(quality_classifier.FEATURES), np.zeros((quality_classifier.FEATURES, quality_classifier.FACTORS))


def test_store_keeps_any_column_and_empty_appends(spark, tmp_path):
    store, docs = sharding.ShardStore(spark, str(tmp_path / "s")), hostile(spark, case=False)
    assert store.append(docs.limit(0)) == 1 and store.read().columns == docs.columns and store.read().count() == 0
    store.append(docs, sharding.arrivals(F.col("doc_id"), 3))
    store.compact()
    assert sorted(map(str, store.read().collect())) == sorted(map(str, docs.collect()))


def test_parts_of_the_manifest(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "PART_SHARDS", 2)
    store, docs = sharding.ShardStore(spark, str(tmp_path / "s")), documents(spark)
    for _ in range(5):
        store.append(docs.coalesce(1))
    store.compact(target=1, fanout=2)  # every shard counts as finished
    manifest = store.manifest()
    assert len(manifest["parts"]) == 2 and len(manifest["shards"]) == 1 and len(store.shards(manifest)) == 5
    assert store.read().count() == 5 * docs.count()
    store.vacuum()
    assert store.read().count() == 5 * docs.count() and store.read(store.versions()[-1]).count() == 5 * docs.count()
