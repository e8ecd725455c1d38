"""Experiment trees come in documents that fit a row."""

from pyspark.sql import functions as F

from axonloom.plans import inputs


def test_a_document_holds_one_cell(spark, sf, monkeypatch):
    seen, flattened = [], inputs.files.flattened
    monkeypatch.setattr(inputs.files, "flattened", lambda trees: seen.append(trees) or flattened(trees))
    assert inputs.source_cells(spark, sf).count() > 0
    cells = F.aggregate(F.flatten(F.transform("animals", lambda a: F.flatten(F.transform(a["preparations"], lambda p: p["cells"])))), F.lit(0), lambda n, _: n + 1)
    assert seen[0].agg(F.max(cells)).first()[0] == 1
