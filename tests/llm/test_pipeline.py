"""The stages of the pipeline against brute force on a small table."""

import hashlib
import re

import corpus_pipeline
from tidewrack.llm import queries, secrets
from tidewrack.llm.pieces import PieceCodec


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(docs.toPandas())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    good, single, clean, mixed, tokens = kept
    original = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    quality = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas().set_index("doc_id").quality
    known = original[original.doc_id.isin(quality.index)]
    right = [(i in set(good.doc_id)) == (quality[i] == 1) for i in known.doc_id]
    assert sum(right) / len(right) > 0.85

    # of equal texts the first stays; shingle sets that are alike to 0.8 don't both
    assert set(single.doc_id) <= set(good.doc_id) and not single.text.duplicated().any()
    assert good.groupby("text").doc_id.min().isin(single.doc_id).mean() > 0.9

    def shingles(t):
        w = t.lower().split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = [shingles(t) for t in single.text]
    alike = sum(len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert alike == 0
    gone = good[~good.doc_id.isin(single.doc_id)]
    every = {i: shingles(t) for i, t in zip(good.doc_id, good.text)}
    for i in gone.doc_id:
        assert max(len(every[i] & every[j]) / len(every[i] | every[j]) for j in every if j != i) >= 0.8

    assert sorted(clean.doc_id) == sorted(single.doc_id)
    before = dict(zip(single.doc_id, single.text))
    for i, t, n in zip(clean.doc_id, clean.text, clean.n_chars):
        assert n == len(t)
        found = [m for _, rx, g, least in secrets.RULES for m in re.finditer(rx, before[i]) if len(m[g]) >= least]
        assert ("[SECRET]" in t) == bool(found)
        assert not found == (t == before[i]) or found

    assert set(mixed.doc_id) <= set(clean.doc_id) and mixed.groupby("doc_id").size().max() <= 4
    codec = PieceCodec(queries.PIECES)
    digests = sorted(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() for ids in codec.encode(mixed.text.tolist()))
    assert sorted(tokens.ids_sha256) == digests
    assert sorted(tokens.decoded_sha256) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in mixed.text)


def test_odd_and_empty_documents(spark, tmp_path):
    """Nulls, empty, very long and repeated texts, clashing columns, and no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long = " ".join(f"wort{i}" for i in range(60_000)) + " " + "x" * 100_000
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, long, "en", "s", len(long)), (4, long + " end", "en", "s", 1), (5, "a b c", "en", None, 5), (5, "a b c", "en", None, 5), (None, "no id at all", "en", "s", 9)]
    for name, some in (("odd", rows), ("none", [])):
        root = str(tmp_path / name)
        spark.createDataFrame(some, schema).write.parquet(f"{root}/documents.parquet")
        spark.createDataFrame([(3, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
        assert corpus_pipeline.run(spark, root).count() <= 4 * len(some)
        docs = spark.read.parquet(f"{root}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, root).columns == docs.columns
    odd = spark.createDataFrame([(*r, 7, True) for r in rows], schema + ", doc_id_goes int, component_id boolean")
    kept = corpus_pipeline.drop_near_duplicates(spark, odd, root)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 5]


def test_run_is_registered(spark, sf_dir):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names}
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
