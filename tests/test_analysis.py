"""The composite analysis functions on the feedback view (sf0.001)."""

import pytest

from feedlake.plans import analysis as A
from feedlake.session import scratch_path
from feedlake.sources.history import history_rows
from feedlake.sources.tables import feedback, rated_orders, vectors

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def fb(spark):
    return feedback(spark, SF_SMALL)


def test_by_level_and_statistics(fb):
    r = A.feedback_by_level(fb, 3)
    assert r["count"].first().n == r["rows"].count() and r["sample"].count() <= 10
    s = A.statistics(fb)
    assert sum(x.n for x in s["level_distribution"].collect()) == fb.filter("level is not null").count()
    assert {x.column_name for x in s["top_values"].collect()} == {"lang", "source"}


def test_filtered_report_writes_csv(spark, fb):
    folder = scratch_path(spark, "reports")
    r = A.filtered_report(fb, {"Level": [4, 5], "lang": "en"}, ["row_id", "Level", "text"], folder=folder)
    assert r.files and r["rows"].columns == ["row_id", "level", "text"]
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(r.files[0])
    assert back.count() == r["rows"].count()


def test_search_modes(spark, fb):
    v = vectors(spark, SF_SMALL)
    corpus = v.join(fb.select("row_id", "text"), "row_id")
    by_index = A.semantic_search(corpus, reference_index=3, top_k=5, similarity_threshold=-1.0)["hits"]
    assert by_index.count() == 5
    ref_id = corpus.orderBy("row_id").collect()[3].row_id
    assert ref_id not in {r.row_id for r in by_index.collect()}
    post = A.semantic_search(corpus, reference_index=3, top_k=5, similarity_threshold=-1.0, post_filter=True)["hits"]
    assert post.count() == 4 and ref_id not in {r.row_id for r in post.collect()}
    with pytest.raises(ValueError):
        A.semantic_search(corpus)


def test_themes(spark, fb):
    v = vectors(spark, SF_SMALL)
    res = A.themes(fb, use_clustering=True, eps=0.65, vectors=v)
    s = res["summary"].first()
    assert s.n_rows == fb.filter("text is not null").count()
    sample = A.themes(fb, filter_by_level=True, at_most=2)
    assert sample["sample"].count() <= 30
    with pytest.raises(ValueError):
        A.themes(fb.limit(2), use_clustering=True, min_cluster_size=3, vectors=v)


def test_category_history_trends_compare(spark, fb):
    rep = A.category_report(fb, at_least=4, rules={"Errors": "err"}, folder=scratch_path(spark, "cat"))
    assert rep.files and rep["counts"].count() == 7
    hist = history_rows(fb, "2024-02-01 00:00:00")
    h = A.history_summary(hist, "2024-01-01", "2024-01-31", limit=50)
    assert h["count"].first().n == h["rows"].count() > 50  # statistics cover all matching rows
    assert h["shown"].count() == 50
    o = rated_orders(spark, SF_SMALL)
    t = A.trends(o, period="year", compare=True)
    assert t["latest_change"].count() == 1
    c = A.compare(o, "1995-01-01", "1995-12-31", "1996-01-01", "1996-12-31")
    assert c["samples_p1"].count() == 10
    with pytest.raises(ValueError, match="first period"):
        A.compare(o, "1980-01-01", "1980-12-31", "1996-01-01", "1996-12-31")
