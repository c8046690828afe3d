"""What Python tasks hold at a time."""

import pandas as pd
import pytest

from plinth.operators import courses, extract, retrieval, tree

HTML = "<html><body>" + "<h2>Fall Term 2026</h2><p>x</p><div>y</div>" * 5000 + "</body></html>"


@pytest.mark.parametrize("nodes", [courses.nodes, tree.nodes, extract.outline])
def test_nodes_leave_a_task_a_few_at_a_time(spark, monkeypatch, nodes):
    pages = spark.createDataFrame([(1, "u", HTML), (2, None, None), (3, "v", HTML)], "page_id long, url string, html string")
    walks = []
    kind = type(pages)
    real = kind.mapInPandas
    monkeypatch.setattr(kind, "mapInPandas", lambda self, f, *a, **k: walks.append(f) or real(self, f, *a, **k))
    n = nodes(pages).count()
    batch = pd.DataFrame({"k": [1, 2, 3], "row": [1, 2, 3], "page": [1, 2, 3], "url": ["u", None, "v"], "html": [HTML, None, HTML]})
    sizes = [len(pdf) for pdf in walks[0](iter([batch]))]
    assert sum(sizes) == n >= 20_000 and max(sizes) <= 5000


def test_counts_leave_a_task_a_few_texts_at_a_time(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "one two") for k in range(2000)], "k long, text string")
    walks, kind = [], type(docs)
    real = kind.mapInPandas
    monkeypatch.setattr(kind, "mapInPandas", lambda self, f, *a, **k: walks.append(f) or real(self, f, *a, **k))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20)
    assert retrieval.term_frequencies(docs, "k", "text").count() == 4000
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 16 << 20
    parts = list(walks[0](iter([pd.DataFrame({"k": range(2000), "x": ["one two"] * 2000})])))
    assert sum(map(len, parts)) == 4000 and max(map(len, parts)) <= 2 * retrieval.TEXTS
