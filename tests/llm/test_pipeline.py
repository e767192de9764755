"""The pipeline's stages, each on what the one before kept."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as cp
from auditlake.llm import langid, linededup, mixing, neardup, packing
from auditlake.llm.common import documents
from tests.llm.test_operators import check_pieces

SF = "/root/testdata/sf0.001"


def texts(df):
    return Counter((r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect())


def test_stages(spark, real, odd, none):
    for docs in (real, odd):
        frames = [docs]
        for name, stage in cp.STAGES[:-1]:
            frames.append(stage(spark, frames[-1], SF).cache())
            assert frames[-1].columns == docs.columns, name
        first, lines, near, mixed = frames[1:]
        model = langid.fit(docs.where(langid.learning_rows(docs)))
        said = langid.identify(docs, model, "doc_id", "text").where("lang_pred <> 'und' and score >= 0.5")
        assert texts(first) == texts(said)
        kept = linededup.drop_lines(first).where("not (n_dropped > 0 and trim(text) = '')")
        assert texts(lines) == texts(kept)
        classes = {(r["doc_id"], r["class_id"]) for r in neardup.near_duplicates(lines).collect()}
        assert near.count() == len({c for _, c in classes}) and {r["doc_id"] for r in near.collect()} == {c for _, c in classes}
        assert not texts(mixed) - texts(near)
        check_pieces([*texts(mixed).elements()], packing.pack(mixed).collect())
    for _, stage in cp.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_run_keeps_clean_documents(spark):
    out = cp.run(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.select("doc_id").distinct().count() > 150


def test_mixing_keeps_good_documents(spark, real):
    """Also where another domain is scarce."""
    good = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 and toxic = 0").select("doc_id")
    kept = cp.mix_sources(spark, real, SF).select("doc_id").distinct()
    assert good.join(kept, "doc_id", "left_anti").count() == 0


def test_mixing_fits_what_it_keeps(spark, monkeypatch):
    """The fitted totals are those of the documents drawn, and the shares reached are those the README names."""
    sf, reports = "/root/testdata/sf0.01", []
    fit = mixing.fit_rates
    monkeypatch.setattr(mixing, "fit_rates", lambda *a, **k: reports.append(fit(*a, **k)) or reports[-1])
    docs = documents(spark, sf)
    kept = cp.mix_sources(spark, docs, sf)
    cells, report = reports[0]
    assert cells.where("rate > 1").count() == 0
    model = mixing.train(docs, mixing.quality_domains(spark.read.parquet(f"{sf}/labels.parquet")), list(mixing.TARGETS))
    got = mixing.posteriors(kept, model).agg(*[F.sum(F.col("n_tokens") * F.get("p", F.lit(i))) for i in range(3)]).first()
    assert all(abs(g / sum(got) - share) < 0.002 for g, share in zip(got, (0.895, 0.085, 0.020)))
    assert all(abs(g - f) <= 0.02 * sum(report["got"]) for g, f in zip(got, report["got"]))
